"""A small table of urls labelled by hand: what a crawl for training text should leave out (1) and what it should keep (0)."""

from __future__ import annotations

#: Adult, gambling, pharmacy and loan offers, link farms, trackers, downloads of doubtful kind, doorway pages.
BLOCK = """
https://hot-singles-near-you.com/join?aff=2231
http://www.freexxxcams.net/live/room/88
https://adult-toys-outlet.com/en/category/12
http://sexy-chat-online.org/index.php?ref=ad
https://erotic-stories-xxx.com/top/15.html
https://escort-agency-vip.com/city/berlin
http://nude-celebs-pics.net/gallery/3/
https://best-online-casino-bonus.com/welcome-offer
http://casino-royal-win.net/play/slots/1
https://www.lucky-slots-jackpot.com/en/register
https://poker-bets-live.com/tables?promo=free
http://sports-betting-tips.net/odds/2024/
https://win-big-lottery.org/claim-prize.html
https://roulette-spin-cash.com/de/bonus/55
http://bingo-bonus-4u.com/free-spins
https://cheap-viagra-pills.com/buy-now
http://www.buy-cialis-online.net/order/10
https://discount-meds-pharmacy.com/no-prescription
http://weightloss-pills-miracle.org/special-offer
https://buy-steroids-cheap.com/shop/77
https://fast-payday-loans.com/apply-now
http://quick-cash-loan-today.net/apply?src=mail
https://bad-credit-loans-approved.com/en/form/3
https://make-money-fast-now.com/start
http://earn-cash-from-home.net/signup/22
https://crypto-doubler-profit.com/invest
http://get-rich-bitcoin-bot.org/?ref=991
https://buy-followers-likes.com/instagram/1000
http://cheap-likes-and-fans.net/packages
https://buy-backlinks-seo.com/pricing/5
http://spam-link-farm.net/directory/482
https://free-link-exchange.org/add-url.php
http://article-spinner-farm.com/page/93
https://clickbait-shocking-news.com/you-wont-believe
http://viral-click-now.net/10-tricks-doctors-hate
https://fake-news-daily-shock.com/story/7
https://ads-tracker-network.com/click?id=55123
http://track.ad-clicks-server.net/pixel.gif?u=1
https://popunder-ads.com/serve/banner/9
http://adserver-track.org/redirect?to=shop
https://doubletrack-ads.net/imp/12345
http://free-download-crack.com/keygen/photoshop
https://warez-cracked-games.net/download/41
http://serial-keygen-free.org/windows/7
https://torrent-movies-free.com/watch/hd/12
http://watch-free-movies-online.net/stream/992
https://free-ringtones-now.com/get?sub=1
http://win-free-iphone.net/survey/1
https://claim-your-gift-card.com/prize/step1
http://you-are-a-winner.org/claim?session=8
https://cheap-replica-watches.com/rolex/2
http://fake-designer-bags.net/shop/handbags
https://cheap-jerseys-outlet.net/nfl/31
http://discount-outlet-cheap-shoes.com/sale/70
https://fake-id-cards-buy.com/order
http://write-my-essay-cheap.com/order-now
https://essays-for-sale.net/buy/term-paper
http://mail-order-brides-dating.com/profiles/3
https://hookup-dating-tonight.com/join
http://adult-dating-free.net/members?page=4
https://psychic-love-spells.com/cast-now
http://miracle-cure-secret.com/order/1
https://spam-blog-auto.com/tag/cheap/page/66
http://doorway-keywords-page.net/cheap+hotel+flights/3
https://scraped-content-copy.com/post/10022
http://parked-domain-ads.com/?kw=insurance
https://click-here-win-cash.com/go
http://bait-clicks-farm.org/en/301
https://hot-deals-spam-mailer.com/unsubscribe?id=4
http://xxx-tube-videos.com/watch/4411
"""
#: Reference works, news, schools, offices, shops and people who write.
ALLOW = """
https://www.city-library.org/en/opening-hours
https://openmaps.org/way/118
http://www.old-town-museum.org/exhibits/2
https://school-garden-club.org/projects/worms
https://science-daily-reader.com/2021/05/ice-cores
http://physics-lecture-notes.edu/chapter/3.html
https://www.university-press.org/books/4411
https://home-recipes-kitchen.com/soups/lentil
http://grandmas-cooking.net/bread/rye/
https://local-weather-report.com/berlin/today
http://weather-station-alps.org/archive/2019
https://history-journal.org/volume/12/article/4
https://medieval-letters.net/de/brief/88
http://www.regional-news.com/politics/2020/11/council
https://morning-herald.net/sport/football/552
https://free-software-directory.org/gnu/emacs
http://docs.compiler-tools.org/manual/parsing.html
https://blog.rustaceans.net/ownership-explained
https://www.bird-watchers.org/species/heron
http://river-ecology.net/papers/17
https://mountain-hiking-trails.com/routes/31
https://bike-repair-guide.net/brakes/disc
http://railway-timetables.org/lines/s7
https://public-health-office.org/advice/vaccines
http://www.hospital-north.org/departments/eyes
https://legal-aid-society.org/tenants/rights
https://parliament-records.org/debates/1998/03
http://tax-office-help.org/forms/12
https://chess-openings.net/sicilian/najdorf
https://poetry-archive.org/poets/rilke
http://book-reviews-weekly.com/2018/44/
https://language-learners.net/es/verbos/ser
https://dictionary-of-names.org/b/bernard
http://wiki.gardeners.net/tomatoes
https://astronomy-club.org/observations/m31
https://www.maths-problems.org/geometry/circles
http://teachers-room.net/worksheets/fractions
https://choir-and-orchestra.org/concerts/may
https://film-history.net/directors/murnau
http://painting-restoration.org/case/9
https://furniture-workshop.com/oak-table
https://family-bakery.net/contact
http://hotel-seaside.com/rooms/double
https://farm-shop-valley.com/cheese
https://company-annual-report.com/2022/en/
http://patent-search.org/view/ep/332
https://open-data-portal.org/dataset/traffic
https://statistics-bureau.org/population/table/5
http://neighbourhood-forum.net/thread/202
https://questions-answers.net/programming/1872
https://travel-notes-anna.net/lisbon/day/2
http://diary-of-a-beekeeper.com/2016/june
https://dental-care-advice.org/children
https://womens-chess-league.org/results/7
http://freedom-of-speech.org/cases/12
https://winter-sports-news.com/ski/jumping
https://hotspring-geology.org/iceland
http://cashmere-knitting.net/patterns/4
https://clicker-training-dogs.org/lesson/1
https://adult-education-centre.org/courses/evening
http://free-clinic-volunteers.org/join
https://loanwords-in-english.net/from/norse
http://wind-farm-engineering.org/turbines/3
https://fake-art-detection.org/methods
https://likeness-portraits.net/gallery/18
http://tracking-wolves.org/maps/2
https://thertha.com/en/12
http://m.tionre.net/fr/7.html
https://blog.handen.org/de/340
http://www.ingthe.com/es/85/
https://antior.net/en/219
http://erthon.org/fr/4
https://ondera.com/de/77?page=2
http://blog.isofed.net/en/51
https://m.entith.org/es/6#top
http://reston.com/en/903
"""


_SITES, _HOSTS, _PATHS = ("", "www.", "m.", "blog."), (".com", ".org", ".net", ".example.com", ".example.org", ".example.net"), ("/", "/en/{}", "/de/{}/", "/fr/{}.html", "/es/{}", "/index.php", "/page/{}")


def labelled(framed: int = 6) -> list[tuple[str, int]]:
    """The table, and each of its names in ``framed`` other frames of subdomain, domain and path, so that the frame says nothing."""
    out = []
    for urls, label in ((BLOCK, 1), (ALLOW, 0)):
        for i, url in enumerate(urls.split()):
            out.append((url, label))
            name = url.split("/")[2].removeprefix("www.").removeprefix("blog.").removeprefix("m.").rsplit(".", 1)[0]
            for j in range(framed):
                k = 7 * i + j
                out.append((f"https://{_SITES[k % 4]}{name}{_HOSTS[k % 6]}{_PATHS[k % 7].format(37 * k % 1000)}", label))
    return out
